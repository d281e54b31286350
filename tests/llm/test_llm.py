"""The training-data operators on small tables: edge cases, and brute force on small fixtures."""

import hashlib
import html
import random
import textwrap
import unicodedata
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from chronoweave.llm import bitplanes, bpe, common, decontaminate, licences, pages, quality, sharding, simhash, substrings, vectors

public_tokenizers = pytest.importorskip("public_tokenizers")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
DOCS_COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
R = random.Random(3)
VOCAB = [f"w{i}" for i in range(40)] + ["é", "ü", "x."]


def words(n):
    return " ".join(R.choice(VOCAB) for _ in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    shared, other = words(60), words(40)
    texts = {0: words(100), 3: "", 4: None, 5: " \t\n ", 6: "one", 7: "a b c", 8: shared, 9: words(20) + "\n" + shared + " " + words(5), 10: shared, 11: "same " * 50, 12: "same " * 40, 13: words(400), 14: other + " " + words(300) + " " + other, 15: other, 16: "x" * 3000, 17: words(30) + " " + shared}
    rows = [(i, t, "en", "src0", len(t or "")) for i, t in texts.items()] + [(8, shared, "en", "src1", 0), (None, shared, "en", "src1", 0), (None, None, None, None, None)]
    return spark.createDataFrame(rows, DOCS), rows


def empty(spark):
    return spark.createDataFrame([], DOCS)


# ---- quality (1)


def test_quality_learns_and_scores_all_rows(spark, docs):
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choice(VOCAB) for _ in range(80)) if i % 3 else "BAD!! " * rng.randrange(20, 300), "en", "s", 0) for i in range(300)]
    df = spark.createDataFrame(rows, DOCS)
    labels = spark.createDataFrame([(i, int(bool(i % 3))) for i in range(300)] + [(1, None), (None, 1)], "doc_id long, quality int")
    model = quality.train(df, labels)
    got = {r["doc_id"]: r["score"] for r in quality.scored(df, model).collect()}
    assert np.mean([(got[i] >= 0.5) == bool(i % 3) for i in range(300)]) > 0.95
    assert quality.scored(docs[0], model).count() == len(docs[1])
    assert all(0 <= r["score"] <= 1 for r in quality.scored(docs[0], model).collect())
    assert quality.scored(empty(spark), model).count() == 0


def test_quality_without_labels(spark, docs):
    none = quality.train(docs[0], spark.createDataFrame([], "doc_id long, quality int"))
    assert {round(r["score"], 6) for r in quality.scored(docs[0], none).collect()} == {0.5}
    one = quality.train(docs[0], spark.createDataFrame([(i, 1) for i in range(20)], "doc_id long, quality int"))
    assert len({round(r["score"], 6) for r in quality.scored(docs[0], one).collect()}) == 1


def test_quality_gradients():
    rng = np.random.default_rng(0)
    x, count = rng.normal(size=(12, 30)), np.array([3, 4, 5])
    y = np.array([1.0, 0.0, 1.0])
    m = quality.fit(x, count, y)
    assert (quality._forward(m, x, count)["score"].round() == y).all()


def test_quality_passages_cover_long_texts(monkeypatch):
    data = b"word " * 100_000
    x, count = quality.passages(np.frombuffer(data, np.uint8), np.array([0, len(data), len(data)]))
    assert count.tolist() == [-(-100_000 // 64), 1] and np.expm1(x[: count[0], 13]).sum().round() == 100_000
    rng = np.random.default_rng(3)
    x, count = rng.normal(size=(9, quality.STYLE + quality.SIGNS)), np.array([4, 5])
    model = quality.fit(x, count, np.array([1.0, 0.0]))
    text = np.frombuffer(" ".join(R.choice(VOCAB) for _ in range(64 * 40)).encode(), np.uint8)
    monkeypatch.setattr(quality, "PIECE", len(text))
    whole = quality._score_long(model, text)
    assert whole == pytest.approx(quality._forward(model, *quality.passages(text, np.array([0, len(text)])))["score"][0])
    monkeypatch.setattr(quality, "PIECE", 2000)
    assert 0 <= quality._score_long(model, text) <= 1
    assert 0 <= quality._score_long(model, np.frombuffer(b"x" * 9000, np.uint8)) <= 1


def test_quality_features_equal_brute_force():
    texts = [words(150), "", "AB! cd, cd 12", "é" * 20 + " x", " \t"]
    data = [t.encode() for t in texts]
    x, count = quality.passages(np.frombuffer(b"".join(data), np.uint8), np.cumsum([0, *map(len, data)]))
    rows = iter(x)
    for text, n in zip(data, count, strict=True):
        w = text.split()
        assert n == max(1, -(-len(w) // 64))
        for k in range(n):
            own, r = w[64 * k : 64 * k + 64], next(rows)
            chars, size = sum(map(len, own)), len(own)
            assert r[13] == pytest.approx(np.log1p(size))
            if size:
                assert r[0] == pytest.approx(sum(65 <= c <= 90 for v in own for c in v) / chars)
                assert r[8] == pytest.approx(sum(a == b for a, b in zip(own, own[1:])) / size)
                assert r[9] == pytest.approx(len(set(own)) / size)
                assert r[11] == pytest.approx(sum(len(v) <= 3 for v in own) / size)
                assert r[12] == pytest.approx(sum(v[-1:] in (b".", b",") for v in own) / size)


def test_quality_with_repeated_and_null_ids(spark):
    rng = random.Random(1)
    rows = [(i % 40 if i % 50 else None, " ".join(rng.choice(VOCAB) for _ in range(80)) if i % 2 else "BAD!! " * rng.randrange(20, 90), "en", "s", 0) for i in range(200)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)] * 3, "doc_id long, quality int")
    one, two = (quality.train(spark.createDataFrame(r, DOCS), labels) for r in (rows, rows[::-1]))
    assert all(np.allclose(one[k], two[k]) for k in one)
    got = quality.scored(spark.createDataFrame(rows, DOCS).withColumn("score", F.lit("clash")), one)
    assert got.count() == 200 and got.where("doc_id is null and score is not null").count() == 4


# ---- BPE (2)


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_tree_equals_whole(monkeypatch, name):
    w = bpe.words_of(public_tokenizers.path(name))
    alphabets = ["abcdefghij", "'s't're ", "éèñßü", "ABC", "  \n\t ", "<|endoftext|>", "123", "́a", "日本語", "!?.,''"]
    for leaf, long_word in ((9, 4), (40, 16), (200, 128)):
        monkeypatch.setattr(bpe, "LEAF", leaf)
        monkeypatch.setattr(bpe, "LONG_WORD", long_word)
        for _ in range(60):
            own = R.sample(alphabets, R.choice([1, 2, 3]))
            text = "".join(R.choice(own) if R.random() < 0.03 else R.choice(R.choice(own)) for _ in range(R.choice([3, 50, 600])))
            want = np.array(w.tok.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
            assert bpe.Tree(w).encode(text).bytes() == want
            assert w.ids_only([text]) == [want]
            ids, out = w.encode([text])
            assert ids == [want] and out == [w.tok.decode(np.frombuffer(want, "<u4").tolist(), skip_special_tokens=False)]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_words_of_all_kinds_of_letters_and_added_tokens(name):
    """Letters of every class of Unicode, those that grow or shrink in small letters, white space of all kinds, added tokens."""
    w, rng = bpe.words_of(public_tokenizers.path(name)), random.Random(13)
    kinds = {}
    for c in range(0x3000):
        kinds.setdefault(unicodedata.category(chr(c)), []).append(chr(c))
    kinds = [v for k, v in sorted(kinds.items()) if k not in ("Cn", "Cs")]
    pieces = ["\u0130", "\u1e9e", "\u01c5", "\u212a", "I\u0307", "  ", "\n", " ", "\n\n", "\t ", "<|endoftext|>", "<|startoftext|>", "<|", "|>", "'s", "ab", "Word", "."]
    texts = ["\u0130stanbul", "x \u0130zmir y", "\n\n<|endoftext|>", "a  <|endoftext|>  b", "<|endoftext|><|endoftext|> \n"]
    texts += ["".join(rng.choice(rng.choice(kinds)) if rng.random() < 0.5 else rng.choice(pieces) for _ in range(rng.choice([2, 4, 8, 20]))) for _ in range(6000)]
    want = [np.array(e.ids, "<u4").tobytes() for e in w.tok.encode_batch(texts, add_special_tokens=False)]
    assert w.ids_only(texts) == want
    assert w.encode(texts)[1] == [w.tok.decode(np.frombuffer(i, "<u4").tolist(), skip_special_tokens=False) for i in want]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_words_beyond_the_kept_table(monkeypatch, name):
    monkeypatch.setattr(bpe, "KNOWN", 20)
    w, rng = bpe.Words(public_tokenizers.path(name)), random.Random(2)
    for _ in range(30):
        texts = [" ".join(rng.choice(("Word", "ab,", "x1", "!?", "\u0130")) + str(rng.randrange(50)) * rng.randrange(2) for _ in range(30)) for _ in range(4)]
        want = [np.array(e.ids, "<u4").tobytes() for e in w.tok.encode_batch(texts, add_special_tokens=False)]
        assert w.ids_only(texts) == want and w.encode(texts)[0] == want


def test_encode_docs_long_and_odd_rows(spark, docs):
    path = public_tokenizers.path("word_bpe_49k.json")
    got = bpe.encode_docs(docs[0], path, spread=500).collect()
    tok = bpe.words_of(path).tok
    want = sorted((str(i), np.array(tok.encode(t or "", add_special_tokens=False).ids, "<u4").tobytes()) for i, t, *_ in docs[1])
    assert sorted((str(r["doc_id"]), bytes(r["ids"])) for r in got) == want
    assert bpe.encode_docs(empty(spark), path).count() == 0


# ---- decontamination (3)


@pytest.mark.parametrize("limit", [1 << 25, 0])
def test_decontamination_equals_brute_force(spark, docs, limit):
    items = [(1, docs[1][6][1]), (2, words(12)), (3, "a b c"), (4, None), (5, "".join(c.upper() if c.isascii() else c for c in docs[1][0][1]) + "!"), (None, "x y z a b"), (6, " ".join(docs[1][11][1].split()[5:45])), (7, "A, b c!"), (8, "one"), (9, " ?! "), (10, "b c d"), (11, "same same")]
    table = spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.matches(docs[0], table, broadcast_bytes=limit).collect()}
    want = set()
    plain = lambda t: "".join(" " if c.isascii() and not c.isalnum() else c.lower() if c.isascii() else c for c in t or "").split(" ")
    for d, t, *_ in docs[1]:
        for i, x in items:
            a, b = [w for w in plain(t) if w], [w for w in plain(x) if w]
            n = min(5, len(b))
            own, s = ({tuple(w[k : k + n]) for k in range(len(w) - n + 1)} for w in (a, b))
            if d is not None and i is not None and n and len(own & s) >= 0.8 * len(s):
                want.add((d, i))
    assert got == want and {(0, 5), (7, 3), (7, 7), (6, 8), (11, 11)} <= want
    assert decontaminate.matches(empty(spark), table).count() == 0
    assert decontaminate.matches(docs[0], table.limit(0), broadcast_bytes=limit).count() == 0


def test_keep_clean_keeps_columns(spark, docs):
    table = spark.createDataFrame([(1, docs[1][6][1])], "item_id long, text string")
    kept = decontaminate.keep_clean(docs[0].withColumn("item_id", F.lit(7)), table)
    assert "item_id" in kept.columns and {r["doc_id"] for r in kept.collect()}.isdisjoint({8, 9, 10, 17})


# ---- pages (4)

PAGE = '<html><head><title>t</title><style>p{{}}</style></head><body><nav><ul><li>Home</li></ul></nav><header>Site</header><div class="cookie-notice">We use cookies</div><article><h1>Title &amp; more</h1><p>First  <b>part</b>&nbsp;here<p>Second<br>line</p><div class="comments"><p>Nice!</p></div><aside>See also</aside><form>Mail</form></article><footer>&copy; x</footer><script>var a="</p>";</script></body>'


def test_pages_structure(spark):
    rows = [(1, "http://a.example/x", PAGE.format()), (2, "http://a.example/y", None), (3, None, ""), (4, "http://a.example/z", "plain &lt;text"), (5, "u", "<article><p>cut of"), (1, "http://a.example/x", PAGE.format())]
    got = sorted((r["page_id"], r["text"]) for r in pages.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect())
    main = "Title & more\nFirst part here\nSecond line"
    assert got == [(1, main), (1, main), (2, ""), (3, ""), (4, "plain <text"), (5, "cut of")]
    assert pages.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_pages_without_container_lose_repeats(spark):
    boiler = "subscribe to our weekly letter and never miss a thing again"
    rows = [(i, f"http://h.example/{i}", f"<body><div>{boiler} now</div><div>own words of page {'abcdef'[i]} that nobody repeats</div></body>") for i in range(4)]
    for r in pages.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect():
        assert "weekly" not in r["text"] and f"page {'abcdef'[r['page_id']]}" in r["text"]


def judge_brute(host):
    """The rules of pages.judge on dictionaries of tuples: host is a list of pages, a page a list of (kind, text)."""
    bodies = ["\n".join(t for k, t in page if k != "drop") for page in host]
    seen = {}
    for body, page in zip(bodies, host, strict=True):
        for _, t in page:
            w = t.split()
            for k in range(len(w) - pages.RUN + 1):
                seen.setdefault(tuple(w[k : k + pages.RUN]), set()).add(body)
    n = len(set(bodies))
    often, some = max(2, n / 2), max(3, n / 10)

    def gone(w, least):
        out = set()
        for k in range(len(w) - pages.RUN + 1):
            if len(seen[tuple(w[k : k + pages.RUN])]) >= least:
                out.update(range(k, k + pages.RUN))
        return out

    texts = []
    for page in host:
        kept, cut = [], []
        for i, (kind, t) in enumerate(page):
            w = t.split()
            if kind == "drop":
                continue
            if kind == "keep":
                g = set(range(len(w))) if len(w) >= pages.RUN and len(gone(w, max(often, pages.MANY))) >= 0.9 * len(w) else set()
            else:
                g = gone(w, min(often, some))
                g = g if len(g) * 2 > len(w) else gone(w, often)
            kept.append([i, " ".join(x for k, x in enumerate(w) if k not in g)])
            cut.append((len(g), i))
        words = sum(len(t.split()) for k, t in page if k != "drop")
        lost = sum(g for g, _ in cut)
        for g, i in sorted(cut, key=lambda c: (-c[0], c[1])):
            if g and words - lost < 0.25 * words:
                lost -= g
                next(k for k in kept if k[0] == i)[1] = page[i][1]
        texts.append("\n".join(t for _, t in kept if t))
    return texts


@pytest.mark.parametrize("letters", [3, 12])
def test_pages_repeats_equal_brute_force(spark, letters):
    rng = random.Random(5)
    vocab = [f"w{i}" for i in range(letters)]
    boiler = " ".join(rng.choice(vocab) for _ in range(9))
    rows = []
    for i in range(24):
        parts = [" ".join(rng.choice(vocab) for _ in range(rng.randrange(1, 40))) for _ in range(3)]
        main = f"<article><p>{parts[0]}</p><p>{boiler}</p></article>" if i % 3 else f"<div>{parts[0]}</div><div>{boiler} {parts[2]}</div>"
        rows.append((i, f"http://h{i % 2}.example/", f"<nav>{boiler}</nav>{main}<footer>{parts[1]}</footer>"))
    rows += [(30, "http://h0.example/", rows[0][2]), (31, "http://h1.example/", "")]
    got = {r["page_id"]: r for r in pages.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for host in ("http://h0.example/", "http://h1.example/"):
        own = [r for r in rows if r[1] == host]
        assert [got[r[0]]["text"] for r in own] == judge_brute([pages.blocks(r[2]) for r in own])
    assert sum(r["by_repeats"] for r in got.values()) > 0 and sum(r["by_structure"] for r in got.values()) > 0


def test_pages_keep_articles_that_a_host_repeats(spark):
    """Three pages of a host share the heading and first paragraph of their articles, nine share all but a word: nothing goes."""
    head = "<h1>The and attion to thanedble the</h1><p>Eriner thanea attion thanedble and the rest of it here</p>"
    rows = [(i, "http://www.h.example/", f"<nav>Home and more of the menu here</nav><article>{head}<p>Own text {i} of the page that nobody has</p></article>") for i in range(3)]
    rows += [(10 + i, "http://two.example/", f"<article>{head}<p>Word {i}</p></article><footer>about us and more of that</footer>") for i in range(9)]
    got = {r["page_id"]: r for r in pages.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for i, _, page in rows:
        inside = page[page.index("<article>") : page.index("</article>")]
        assert got[i]["text"].split("\n") == [b for b in inside.replace("<h1>", "<p>").replace("</h1>", "</p>").replace("<article>", "").replace("</p>", "").split("<p>") if b]
        assert got[i]["by_repeats"] == 0


def test_suffix_array_equals_sorted_suffixes():
    rng = random.Random(8)
    for n, k in ((0, 2), (1, 1), (50, 2), (200, 3), (300, 40)):
        streams = []
        while sum(map(len, streams)) < n:
            streams.append([rng.randrange(k) for _ in range(rng.randrange(1, 40))])
        tokens = np.array([t for x in streams for t in x], np.int64)
        left = np.array([len(x) - i for x in streams for i in range(len(x))], np.int64)
        if not len(tokens):
            continue
        order, shared = pages.suffix_array(tokens, left)
        cut = [tuple(tokens[i : i + min(left[i], 32)].tolist()) for i in order]
        assert cut == sorted(cut)
        for a, b, n_shared in zip(cut, cut[1:], shared[1:], strict=False):
            assert n_shared == next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))


def test_pages_unclosed_boxes_comments_and_shared_text(spark):
    assert pages.blocks('<div class="ad">buy now<article><p>The text</p></article>') == [("drop", "buy now"), ("keep", "The text")]
    assert pages.blocks('<article><p>Text</p></article><section id="comments"><article class="comment"><p>Nice</p></article></section>') == [("keep", "Text"), ("drop", "Nice")]
    assert pages.blocks('<div class="post"><p>Text</p></div><article class="comment"><p>Nice</p></article>') == [("keep", "Text"), ("drop", "Nice")]
    assert pages.blocks('<article class="post tag-social related"><p>Text</p></article>') == [("keep", "Text")]
    assert pages.blocks('<nav>Home<article class="reply"><p>Nice</p></article></nav>') == [("drop", "Home"), ("drop", "Nice")]
    shared = "a text of some length that stands on two pages of a host, whose menus differ"
    rows = [(1, "http://s.example/a", f"<div>menu one two</div><div>{shared}</div>"), (2, "http://s.example/b", f"<div>menu three four</div><div>{shared}</div>")]
    got = {r["page_id"]: r["text"] for r in pages.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {1: f"menu one two\n{shared}", 2: f"menu three four\n{shared}"}


def test_pages_of_large_hosts_and_hot_rows(spark):
    rng = random.Random(13)
    boiler = "write to us at any time of the day or night"
    rows = [(i, "http://big.example/x", f"<article><p>{' '.join(rng.choice(VOCAB) for _ in range(40))} {i}</p><p>{boiler}</p></article>") for i in range(120)] + [(7, "http://big.example/x", "<p>equal rows</p>")] * 100 + [(None, None, None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit("clash"))
    for big_hosts in (100, 0):
        got = pages.extract(df, host_bytes=8000, tokens=2000, big_hosts=big_hosts).collect()
        assert len(got) == len(rows)
        assert all(boiler not in r["text"] for r in got)
        assert sum(r["text"] == "equal rows" for r in got) == 100


@pytest.mark.parametrize("letters", [4, 14])
def test_pages_of_large_hosts_have_shares_of_the_whole_host(spark, letters):
    rng = random.Random(21)
    vocab = [f"w{i}" for i in range(letters)]
    lines = [" ".join(rng.choice(vocab) for _ in range(8)) for _ in range(6)]
    rows = []
    for i in range(90):
        words = [" ".join(rng.choice(vocab) for _ in range(rng.randrange(1, 30))) for _ in range(2)]
        said = [x for k, x in enumerate(lines) if rng.random() < (0.04, 0.09, 0.12, 0.45, 0.55, 0.9)[k]]
        main = f"<article><p>{words[0]}</p>{''.join(f'<p>{x}</p>' for x in said)}</article>" if i % 3 == 0 else f"<div>{words[0]}</div>{''.join(f'<div>{x}</div>' for x in said)}<div>{words[1]}</div>"
        rows.append((i, f"http://h{i % 2}.example/", f"<nav>{lines[0]} {i}</nav>{main}"))
    rows += [(100 + i, "http://h0.example/", f"<footer>{lines[1]} {i}</footer>" if i % 2 else rows[0][2]) for i in range(12)] + [(200, "http://h1.example/", "")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    want = {}
    for host in ("http://h0.example/", "http://h1.example/"):
        own = [r for r in rows if r[1] == host]
        want |= dict(zip([r[0] for r in own], judge_brute([pages.blocks(r[2]) for r in own]), strict=True))
    for host_bytes, tokens in ((1 << 20, 1 << 20), (1500, 60), (4000, 400), (100, 1)):
        got = {r["page_id"]: r["text"] for r in pages.extract(df, host_bytes=host_bytes, tokens=tokens).collect()}
        assert got == want, (host_bytes, tokens)


def test_pages_keep_prose_that_recurs_now_and_then(spark):
    rng = random.Random(9)
    prose = {i: [f"v{rng.randrange(10**6)}" for _ in range(120)] for i in range(12)}
    for i in (1, 2):
        prose[i][40:50] = "ten words of a saying that two pages quote whole".split()
    boiler = "we send a letter each week to all who ask for it"
    rows = [(i, f"http://h.example/{i}", f"<body><div>{' '.join(w)}</div><div>{boiler}</div></body>") for i, w in prose.items()]
    rows += [(12, "http://h.example/copy", rows[3][2]), (13, "http://two.example/a", "<div>a page that stands at two places of its host</div>"), (14, "http://two.example/b", "<div>a page that stands at two places of its host</div>")]
    got = {r["page_id"]: r["text"] for r in pages.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    want = {i: " ".join(w) for i, w in prose.items()}
    assert got == want | {12: want[3], 13: "a page that stands at two places of its host", 14: "a page that stands at two places of its host"}


def test_pages_main_with_a_teaser():
    prose, teaser = "<p>" + "long text " * 30 + "</p>", "<article><p>Read this too</p></article>"
    text = ("long text " * 30).strip()
    assert pages.blocks(f"<main>{prose}{teaser}</main>") == [("keep", text), ("keep", "Read this too")]
    assert pages.blocks(f"<main>{prose}</main>{teaser}") == [("keep", text), ("drop", "Read this too")]
    assert pages.blocks(f"<div class='post'>{prose}</div>{teaser}") == [("keep", text), ("drop", "Read this too")]
    assert pages.blocks(f"<main><p>More posts</p><article>{prose}</article></main>") == [("drop", "More posts"), ("keep", text)]


# ---- licences (5)


def test_licences(spark):
    rows = [(1, "x\nReleased under the MIT License.\ny", "", "", 0), (2, "Licensed under the Apache License, Version 1.1.", "", "", 0), (3, "This work is licensed under the GNU General Public License, version 2.", "", "", 0), (4, licences.TEMPLATES[2][2].replace(" this ", " this\n"), "", "", 0), (5, "my driving license was lost", "", "", 0), (6, None, "", "", 0), (7, "", "", "", 0), (8, "Licensed under CC BY-NC 4.0.\nLicensed under CC BY 4.0.", "", "", 0)]
    got = {(r["doc_id"], r["license"]) for r in licences.scan(spark.createDataFrame(rows, DOCS)).collect()}
    assert got == {(1, "MIT"), (3, "GPL-2.0"), (4, "MIT"), (8, "CC-BY-NC-4.0"), (8, "CC-BY-4.0")}
    assert licences.scan(empty(spark)).count() == 0


def test_licences_inside_long_lines():
    rng, scanner = random.Random(7), licences.Scanner()
    for name, must, grant in licences.TEMPLATES:
        line = " ".join(rng.choice(VOCAB) for _ in range(1500))
        text = f"first\n{line} {grant} {line}\nlast"
        assert [r[:2] for r in scanner.scan(text)] == ([] if must.startswith("^") else [(1, name)])  # a heading has a line of its own


def test_licences_report_every_grant_of_a_block():
    grants = [(name, grant) for name, must, grant in licences.TEMPLATES if not must.startswith("^")]
    for sep in (" ", "\n"):
        text = sep.join(grant for _, grant in grants)
        assert [r[1] for r in licences.Scanner().scan(text)] == [name for name, _ in grants]


BSD3 = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.

3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.
"""


def test_licences_wrapped_grants():
    scanner = licences.Scanner()
    for width in (12, 30, 72):
        for lead in ("", "# ", " * "):
            for name, _, grant in licences.TEMPLATES:
                text = "before\n\n" + "\n".join(lead + x for x in textwrap.wrap(grant, width, break_long_words=False)) + "\n\nafter"
                assert [(r[0], r[1], r[3]) for r in scanner.scan(text)] == [(2, name, 1.0)]
    assert [r[1] for r in scanner.scan(BSD3)] == [r[1] for r in scanner.scan(" ".join(BSD3.split()))] == ["BSD-3-Clause"]
    assert [r[1] for r in scanner.scan(BSD3[: BSD3.index("3. Neither")])] == ["BSD-2-Clause"]


def test_licences_headings_tags_and_headers():
    one = lambda text: [r[1] for r in licences.Scanner().scan(text)]
    for name in licences.SPDX:
        assert one(f"# SPDX-License-Identifier: {name}\nimport os\n") == one(f"/* SPDX-License-Identifier: {name} */ int x;") == [name]
    assert one("SPDX-License-Identifier: MIT OR Apache-2.0") in (["MIT"], ["Apache-2.0"])
    assert one("x\n\nMIT License\n\nCopyright (c) 2020 A. Body\n") == one("  # The MIT License (MIT)\n") == ["MIT"]
    assert one("he said that the MIT license was short") == []
    assert one("                    GNU GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007\n") == ["GPL-3.0"]
    assert one("                    GNU GENERAL PUBLIC LICENSE\n                       Version 2, June 1991\n") == ["GPL-2.0"]
    assert one("                   GNU LESSER GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007\n") == ["LGPL-3.0"]
    header = "Licensed under the Apache License, Version 2.0 (the \"License\");\n   you may not use this file except in compliance with the License.\n   You may obtain a copy of the License at\n\n       http://www.apache.org/licenses/LICENSE-2.0\n"
    assert one(header) == one(header.upper()) == ["Apache-2.0"]


def test_licences_equal_brute_force():
    """Random texts of whole, thinned and foreign grants between words: the scanner finds what a comparison of every template at
    every place without anchors, hints and compression finds."""
    rng, scanner = random.Random(21), licences.Scanner()
    plain = licences.Scanner(gain=float("-inf"))
    for _ in range(60):
        parts, want = [], []
        for _ in range(rng.randrange(1, 5)):
            k = rng.randrange(len(licences.TEMPLATES))
            name, must, text = licences.TEMPLATES[k]
            ws = text.split()
            for _ in range(len(ws) // 12):
                at = rng.randrange(1, len(ws))
                if not set(licences._words(ws[at])) & set(must.split()) and ws[at][-1].isalpha():
                    del ws[at]
            parts += [" ".join(rng.choice(VOCAB[:40]) for _ in range(rng.randrange(0, 60))) + ".", "\n".join(textwrap.wrap(" ".join(ws), rng.choice((20, 400)), break_long_words=False, break_on_hyphens=False)), ""]
            want.append(name)
        text = "\n\n".join(parts)
        got = scanner.scan(text)
        assert [r[1] for r in got] == want, (want, [r[:4] for r in got], text)
        assert [r[:2] for r in plain.scan(text)] == [r[:2] for r in got]
        for line, name, reduction, share, _, _ in got:
            assert reduction > 0 and share >= 0.85 and 0 <= line <= text.count("\n")


def test_licences_hint_is_in_every_wrapped_grant(spark):
    rows = [(i, "\n".join(grant.split()), "", "", 0) for i, (_, _, grant) in enumerate(licences.TEMPLATES)]
    got = sorted((r["doc_id"], r["license"]) for r in licences.scan(spark.createDataFrame(rows, DOCS)).collect())
    assert got == [(i, name) for i, (name, _, _) in enumerate(licences.TEMPLATES)]


# ---- substrings (6)


def sized(run, piece):
    def inner(batches):
        from chronoweave.llm import substrings as own

        own.PIECE = piece
        yield from run(batches)

    return inner


def brute_removed(rows):
    first = {}
    for i, t, *_ in rows:
        w = (t or "").encode().split()
        for k in range(len(w) - 12):
            g = tuple(w[k : k + 13])
            first[g] = min(first.get(g, 1 << 70), i if i is not None else substrings.LAST)
    out = []
    for i, t, *_ in rows:
        w = (t or "").encode().split()
        gone = [False] * len(w)
        for k in range(len(w) - 12):
            if first[tuple(w[k : k + 13])] < (i if i is not None else substrings.LAST):
                gone[k : k + 13] = [True] * 13
        out.append((str(i), len(w), sum(gone), b" ".join(x for x, g in zip(w, gone) if not g).decode()))
    return sorted(out)


@pytest.mark.parametrize("piece", [1 << 20, 300])
def test_substrings_equal_brute_force(spark, docs, monkeypatch, piece):
    monkeypatch.setattr(substrings, "_blocks", sized(substrings._blocks, piece))  # workers have a module of their own
    for part in ("_anchors", "_windows", "_cutter"):
        monkeypatch.setattr(substrings, part, lambda *a, make=getattr(substrings, part): sized(make(*a), piece))
    rng = random.Random(9)
    more = [(100 + i, " ".join(rng.choice("ab") for _ in range(60)), "", "", 0) for i in range(30)]
    rows = docs[1] + more
    df = spark.createDataFrame(rows, DOCS).withColumn("n_words", F.lit("clash"))
    got = sorted((str(r["doc_id"]), r["n_words"], r["n_removed"], r["kept_text"]) for r in substrings.remove_repeats(df).collect())
    assert got == brute_removed(rows)
    same = substrings.remove_repeats(df).select(*DOCS_COLUMNS).collect()
    assert sorted(map(str, same)) == sorted(map(str, df.select(*DOCS_COLUMNS).collect()))
    distinct = [r for r in rows if r[0] is not None and r[4] != 0 or r[0] in (3, 4)]  # doc_ids do not repeat: rows go by the id alone
    got = sorted((str(r["doc_id"]), r["n_words"], r["n_removed"], r["kept_text"]) for r in substrings.remove_repeats(spark.createDataFrame(distinct, DOCS)).collect())
    assert got == brute_removed(distinct)
    assert substrings.remove_repeats(empty(spark)).count() == 0


def test_long_words_of_two_letters_are_told_apart(spark):
    """The sequence of Thue and Morse and its complement are equal under every polynomial modulo 2**64."""
    a = "".join("ab"[bin(i).count("1") % 2] for i in range(1024))
    b = a.translate(str.maketrans("ab", "ba"))
    lead = " ".join(VOCAB[:12])
    rows = [(1, f"{lead} {a}", "", "", 0), (2, f"{lead} {b}", "", "", 0), (3, f"{lead} {a} end", "", "", 0)]
    got = {r["doc_id"]: r["n_removed"] for r in substrings.remove_repeats(spark.createDataFrame(rows, DOCS)).collect()}
    assert got == {1: 0, 2: 0, 3: 13}
    data = np.frombuffer(f"{a} {b} ab ba".encode(), np.uint8)
    starts, ends, _ = common.word_bounds(data, np.array([0, len(data)]))
    h = [common.word_hashes(data, starts, ends, base=base) for base in (common.BASE, common.SECOND)]
    assert len(set(h[0])) == len(set(h[1])) == 4 and not set(h[0]) & set(h[1])


def test_recompression_is_local():
    rng = np.random.default_rng(2)
    for _ in range(200):
        shared = rng.integers(1, 5, 13).astype(np.uint64)
        seen = []
        for _ in range(2):
            text = np.concatenate([rng.integers(1, 5, rng.integers(0, 9)).astype(np.uint64), shared, rng.integers(1, 5, rng.integers(0, 9)).astype(np.uint64)])
            first = np.zeros(len(text), bool)
            first[0] = True
            s = next(k for k in range(len(text)) if (text[k : k + 13] == shared).all() and k + 13 <= len(text))
            at, names = substrings.recompress(common.mix(text), first)
            ends = np.append(at[1:], len(text))
            assert (ends - at).max() <= substrings.LONGEST
            seen.append([(b - s, n) for b, e, n in zip(at, ends, names) if b >= s + 2 and e <= s + 11])
        assert seen[0] == seen[1] and seen[0]


# ---- sharding (7)


def tree_brute(groups, shards, first=0, span=None):
    """groups: (coordinates, group key) -> weight; the k-d tree by recursion on sorted lists."""
    if shards == 1 or len(groups) <= 1:
        return {g: first for g in groups}
    dims = range(len(next(iter(groups))[0]))
    wide = [float(max(g[0][i] for g in groups)) - min(g[0][i] for g in groups) for i in dims]
    span = span or [w or 1.0 for w in wide]
    d = max(dims, key=lambda i: wide[i] / span[i])
    order = sorted(groups, key=lambda g: (g[0][d], *g[0], *g[1]))
    total = sum(groups.values())
    want, at = total * (shards // 2) // shards, 0
    for k, g in enumerate(order):
        if at + groups[g] >= want:
            k += at + groups[g] - want <= want - at
            break
        at += groups[g]
    out = {}
    for part, m, f in ((order[:k], shards // 2, first), (order[k:], shards - shards // 2, first + shards // 2)):
        if part:
            out |= tree_brute({g: groups[g] for g in part}, m, f, span)
    return out


@pytest.mark.parametrize("shards", [1, 3, 8])
def test_sharding_equals_brute_force(spark, shards):
    rng = random.Random(4)
    texts = ["x" * rng.randrange(1, 400) + str(rng.randrange(90)) for _ in range(500)] + ["copy"] * 300 + ["big" * 50] * 5 + [f"thirty {i % 40} " * 9 for i in range(1200)]
    rows = [(i, rng.choice("abc"), rng.randrange(6), len(t) + 1, zlib.crc32(t.encode())) for i, t in enumerate(texts)] + [(None, None, None, 1, 0), (7, "a", 5, 1, 0)]
    df = spark.createDataFrame(rows, "doc_id long, lang string, source int, size long, same long").withColumn("code", F.ascii("lang"))
    clash = df.withColumns({c: F.lit("clash") for c in ("shard", "node", "weight", "g0", "keys", "low", "dim", "o", "part", "slot", "at", "first", "n")})
    out = sharding.slots(sharding.assign(clash, shards, ["code", "source", "size"], ["same"]), ["doc_id"]).toPandas()
    assert len(out) == len(rows) and set(clash.columns) | {"shard", "slot"} == set(out.columns)
    groups, low = {}, {}
    for _, lang, source, size, same in rows:
        own = tuple(sharding.LOWEST if v is None else v for v in (ord(lang) if lang else None, source, size))
        low[same] = tuple(map(min, low.get(same, own), own))
        groups[same] = groups.get(same, 0) + size
    want = tree_brute({(low[g], (g,)): w for g, w in groups.items()}, shards)
    assert {(r.same, r.shard) for r in out.itertuples()} == {(g[1][0], s) for g, s in want.items()}
    total = out.groupby("shard")["size"].sum()
    assert (abs(total - total.sum() / shards) <= 3 * max(groups.values()) / 2 + 1).all()
    for _, g in out.groupby("shard"):
        assert sorted(g["slot"]) == list(range(len(g)))


def test_sharding_of_odd_tables(spark):
    schema = "doc_id long, size long, same long"
    assert sharding.slots(sharding.assign(spark.createDataFrame([], schema), 8, ["size"], ["same"]), ["doc_id"]).count() == 0
    one = spark.createDataFrame([(i, 5, 9) for i in range(50)], schema)
    assert sharding.assign(one, 8, ["size"], ["same"]).select("shard").distinct().count() == 1


# ---- SimHash (8)


def simhash_brute(text):
    w = (text or "").encode().lower().split()
    g = [b" ".join(w[i : i + 4]) for i in range(len(w) - 3)] or ([b" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(x, 42) for x in g]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


@pytest.mark.parametrize("tile", [512, 3])
def test_simhash_components_equal_brute_force(spark, docs, monkeypatch, tile):
    rng = random.Random(6)
    base = [rng.choice(VOCAB) for _ in range(300)]
    rows = list(docs[1])
    for i in range(60):
        near = list(base)
        for _ in range(i % 4):
            near[rng.randrange(300)] = "new"
        rows.append((200 + i, " ".join(near), "", "", 0))
    df = spark.createDataFrame(rows, DOCS)
    prints = [(i, simhash_brute(t)) for i, t, *_ in rows]
    got = {(str(r["doc_id"]), r["fp"] & (1 << 64) - 1) for r in simhash.fingerprints(df).collect()}
    assert got == {(str(i), f) for i, f in prints}
    points = spark.createDataFrame([(min(i for i, f in prints if f == x and i is not None), x - (1 << 64) if x >> 63 else x) for x in {f for i, f in prints if i is not None}], "node long, fp long")
    links = simhash.near_links(points, tile=tile).collect()
    assert all(r["a"] != r["b"] for r in links)
    more = simhash.near_links(points, tile=tile, blocks=8).collect()
    same = [common.components(spark.createDataFrame(x, "a long, b long")).collect() for x in (links, more)]
    assert sorted(same[0]) == sorted(same[1])
    label = {i: i for i, _ in prints if i is not None}
    known = [(i, f) for i, f in prints if i is not None]
    changed = True
    while changed:
        changed = False
        for i, f in known:
            low = min(label[j] for j, g in known if bin(f ^ g).count("1") <= 4)
            changed, label[i] = changed or low < label[i], min(low, label[i])
    monkeypatch.setattr(simhash, "TILE", tile)
    out = simhash.near_components(df).collect()
    assert len(out) == len(rows)
    assert {(r["doc_id"], r["component_id"]) for r in out if r["doc_id"] is not None} == set(label.items())
    kept = [r["doc_id"] for r in simhash.near_dedup(df).collect()]
    assert sorted(x for x in kept if x is not None) == sorted(set(label.values())) and kept.count(None) == 2
    assert simhash.near_components(empty(spark)).count() == 0


def test_components_of_chains_and_hubs(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 60)] + [(7, 7)]
    got = {r["node"]: r["component"] for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(1, 41)}, **{100 + i: 100 for i in range(1, 60)}}


def test_block_masks_leave_no_pair_out():
    assert [simhash.block_count(n, 4) for n in (0, 1000, 1 << 20, 1 << 21, 10**8, 10**10)] == [6, 6, 6, 7, 7, 9]
    for blocks in (6, 7, 8, 9):
        masks = simhash.block_masks(4, blocks)
        for _ in range(300):
            x, flips = R.getrandbits(64), R.sample(range(64), 4)
            y = x
            for b in flips:
                y ^= 1 << b
            assert any(x & m == y & m for m in masks)


# ---- vectors (9)


def test_vectors_recall_and_odd_rows(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(1500, 16)).astype(np.float32)
    rows = [(i, x[i].tolist()) for i in range(1500)] + [(2000 + i, x[3].tolist()) for i in range(40)] + [(3000, None), (3100, [0.0] * 16), (3200, [float("nan")] * 16), (3300, [None] * 16), (3400, [1.0]), (None, x[0].tolist()), (5, x[5].tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = vectors.search(df, F.col("vec_id") % 50 == 0, leaf_rows=60).toPandas()
    good = [(i, np.array(v, np.float64)) for i, v in {i: v for i, v in rows if i is not None and v is not None and len(v) == 16 and all(c is not None and np.isfinite(c) for c in v) and any(v)}.items()]
    ids, m = np.array([i for i, _ in good]), np.stack([v for _, v in good])
    hits = 0
    for q in ids[ids % 50 == 0]:
        d = np.sqrt(((m - m[ids == q][0]) ** 2).sum(axis=1))
        want = [int(ids[k]) for k in np.lexsort((ids, d)) if ids[k] != q][:10]
        own = got[got["query_id"] == q].sort_values("rank")
        assert own["rank"].tolist() == list(range(1, 11))
        assert own[["score", "vec_id"]].apply(tuple, axis=1).is_monotonic_increasing
        hits += len(set(want) & set(own["vec_id"]))
    assert hits >= 0.9 * 10 * (ids % 50 == 0).sum()
    assert vectors.search(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0


# ---- token planes (10)


@pytest.mark.parametrize("kind", ["byte", "bit"])
def test_planes_round_trip(kind):
    rng = np.random.default_rng(1)
    for n in (1, 7, 8, 1000):
        ids = rng.integers(0, 1 << 32, n, dtype=np.uint64).astype("<u4")
        assert (bitplanes.from_planes(bitplanes.to_planes(ids, kind), n, kind) == ids).all()


@pytest.mark.parametrize("kind", ["byte", "bit"])
def test_write_and_read(spark, docs, tmp_path, kind):
    path = public_tokenizers.path("byte_bpe_50k.json")
    df, rows = docs
    bitplanes.write(df, path, str(tmp_path / "ids"), kind=kind, block=64, chunk=500)
    tok, at, want = bpe.words_of(path).tok, 0, {}
    got = {r["doc_id"]: (r["start"], bytes(r["ids"])) for r in bitplanes.read(spark, str(tmp_path / "ids")).where("doc_id > 8").collect()}
    for i, t, *_ in sorted(rows, key=lambda r: -1 if r[0] is None else r[0]):
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 0], "<u4").tobytes()
        want[i] = (at, ids)
        at += len(ids) // 4
    assert got == {i: v for i, v in want.items() if i is not None and i > 8}
    bitplanes.write(empty(spark), path, str(tmp_path / "none"))
    assert bitplanes.read(spark, str(tmp_path / "none")).count() == 0


# ---- pipeline


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(2)
    rows = [(i, "\n".join(" ".join(rng.choice(VOCAB) for _ in range(30)) for _ in range(4)) if i % 4 else "BAD!! " * 90, "en", "s", 0) for i in range(160)]
    rows[9] = (9, rows[5][1], "en", "s", 0)
    item = rows[11][1].split("\n")[1]
    spark.createDataFrame(rows, DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, int(bool(i % 4)), 0) for i in range(160)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "SimHash near-dedup", "substring dedup", "benchmark decontamination", "BPE encoding and decoding"]
    out = corpus_pipeline.run(spark, str(tmp_path)).toPandas()
    assert set(out["doc_id"]) == {i for i in range(160) if i % 4} - {9, 11}
    tok = bpe.words_of(public_tokenizers.path("word_bpe_49k.json")).tok
    ids = tok.encode(rows[1][1], add_special_tokens=False).ids
    assert out[out["doc_id"] == 1]["ids_sha256"].iloc[0] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()


def test_pipeline_of_odd_tables(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(12)
    text = lambda: " ".join(rng.choice(VOCAB) for _ in range(60))
    rows = [(i, text() if i % 3 else "BAD!! " * 50, "en", "s", 0) for i in range(90)] + [(200, None, None, None, None), (201, "", "en", "s", 0), (None, text(), "en", "s", 0), (7, text(), "en", "s", 0), (202, text() * 40, "en", "s", 0)]
    rows += [rows[10], rows[10]]
    labels = spark.createDataFrame([(i, int(bool(i % 3)), 0) for i in range(90)], "doc_id long, quality int, toxic int")
    items = spark.createDataFrame([(1, None), (None, "w1 w2"), (2, "")], "item_id long, text string")
    for name, docs in (("odd", spark.createDataFrame(rows, DOCS)), ("none", empty(spark))):
        d = tmp_path / name
        docs.withColumn("score", F.lit("clash")).withColumn("node", F.lit(1)).write.parquet(str(d / "documents.parquet"))
        labels.write.parquet(str(d / "labels.parquet"))
        items.write.parquet(str(d / "benchmark.parquet"))
        out = corpus_pipeline.run(spark, str(d)).toPandas()
        assert sorted(out.columns) == ["decoded_sha256", "doc_id", "ids_sha256", "n_tokens"]
        if name == "none":
            assert out.empty
        else:
            ids = out["doc_id"].dropna().astype(int).tolist()
            assert len(ids) == len(set(ids)) and {1, 2, 4, 5, 202} <= set(ids) and not {3, 6, 9} & set(ids)


def test_pipeline_equals_its_stages_by_brute_force(spark, tmp_path):
    """Each stage's rows against plain Python over the rows that the one before kept (the classifier against its own scores)."""
    import corpus_pipeline

    rng = random.Random(23)
    shared = " ".join(rng.choice(VOCAB) + str(rng.randrange(50)) for _ in range(70))
    rows = [(i, " ".join(rng.choice(VOCAB) + str(rng.randrange(50)) for _ in range(80)) if i % 4 else "BAD!! " * 60, "en", "s", 0) for i in range(120)]
    rows = [(i, t + (" " + shared if i % 10 == 1 else ""), *rest) for i, t, *rest in rows]
    rows[30] = (30, rows[5][1], "en", "s", 0)
    item = " ".join(rows[77][1].split()[3:40])
    for name, table in (("documents", spark.createDataFrame(rows, DOCS)), ("labels", spark.createDataFrame([(i, int(bool(i % 4)), 0) for i in range(120)], "doc_id long, quality int, toxic int")), ("benchmark", spark.createDataFrame([(1, item)], "item_id long, text string"))):
        table.write.parquet(str(tmp_path / f"{name}.parquet"))
    stages = [f for _, f in corpus_pipeline.STAGES]
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    kept = stages[0](spark, docs, str(tmp_path)).collect()
    assert {r.doc_id for r in kept} == {i for i in range(120) if i % 4 or i == 30}
    docs = spark.createDataFrame(kept, DOCS)
    prints = {r.doc_id: simhash_brute(r.text) for r in kept}
    label = {i: i for i in prints}
    while True:
        low = {i: min(label[j] for j, g in prints.items() if bin(f ^ g).count("1") <= 4) for i, f in prints.items()}
        if low == label:
            break
        label = low
    kept = stages[1](spark, docs, str(tmp_path)).collect()
    assert {r.doc_id for r in kept} == set(label.values())
    docs = spark.createDataFrame(kept, DOCS)
    want = {int(i): (t, n) for i, _, n, t in brute_removed([tuple(r) for r in kept])}
    kept = stages[2](spark, docs, str(tmp_path)).collect()
    assert len(kept) == len(want) and any(n for _, n in want.values())
    assert all(r.text == (want[r.doc_id][0] if want[r.doc_id][1] else next(x[1] for x in rows if x[0] == r.doc_id)) for r in kept)
    docs = spark.createDataFrame(kept, DOCS)
    s = decontaminate.shingles(item.encode())
    clean = [r for r in kept if len(decontaminate.shingles(r.text.encode()) & s) < 0.8 * len(s)]
    kept = stages[3](spark, docs, str(tmp_path)).collect()
    assert {r.doc_id for r in kept} == {r.doc_id for r in clean} and 77 not in {r.doc_id for r in kept}
    tok = bpe.words_of(public_tokenizers.path("word_bpe_49k.json")).tok
    out = {r.doc_id: r.ids_sha256 for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert out == {r.doc_id: hashlib.sha256(np.array(tok.encode(r.text, add_special_tokens=False).ids, "<u4").tobytes()).hexdigest() for r in kept}
