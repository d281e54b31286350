"""The n-gram Jaccard join against all pairs of shingle sets."""

import random

import pytest

from chronoweave.llm import ngrams

VOCAB = [f"w{i}" for i in range(400)]
DOCS = "doc_id long, text string, lang string, n int, node string, elem string"


def classes(rows):
    sets = []
    for r in rows:
        w = (r[1] or "").lower().split()
        sets.append(frozenset([tuple(w)] if 0 < len(w) < 5 else [tuple(w[i : i + 5]) for i in range(len(w) - 4)]))
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            k = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * k >= 80 * (len(sets[i]) + len(sets[j]) - k):
                root[find(i)] = find(j)
    low = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            low[find(i)] = min(low.get(find(i), r[0]), r[0])
    return sorted(((r[0], len(s), low.get(find(i)) if s else r[0]) for i, (r, s) in enumerate(zip(rows, sets, strict=True))), key=str)


def corpus(seed):
    rng, texts = random.Random(seed), []
    for _ in range(60):
        base = [rng.choice(VOCAB) for _ in range(rng.choice([1, 2, 3, 5, 6, 8, 9, 12, 13, 14, 15, 18, 20, 22, 25, 30, 40, 60, 100, 300]))]
        for _ in range(rng.choice([1, 2, 5, 20])):
            w = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
                w[rng.randrange(len(w))] = rng.choice(VOCAB)
            w = w[rng.randrange(2 + len(w) // 12) :] if rng.random() < 0.4 else w
            texts.append(" ".join(w).upper() if rng.random() < 0.2 else " \t".join(w))
    passage = " ".join(VOCAB[:60])  # in a third of all texts
    texts += [passage + " " + " ".join(rng.choice(VOCAB) for _ in range(rng.choice([5, 10, 15, 40]))) for _ in range(150)]
    texts += [None, "", " \n ", "a b", "A B", "one", "k " * 300, "k " * 200, " ".join(VOCAB * 50), " ".join(VOCAB * 50 + ["end"])]
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    rows += [(3, "a text of its own under an id that is taken"), (None, texts[5]), (None, "nobody else has this text at all"), rows[0]]
    return [(*r, "en", 0, "x", None) for r in rows]


@pytest.mark.parametrize(("seed", "boundary", "tile"), [(0, None, 512), (1, 12, 4), (2, 24, 512), (3, 1, 4)])
def test_classes_are_those_of_all_pairs(spark, monkeypatch, seed, boundary, tile):
    rows = corpus(seed)
    monkeypatch.setattr(ngrams.open_pairs, "__defaults__", (tile,))
    got = ngrams.jaccard_components(spark.createDataFrame(rows, DOCS), boundary=boundary).collect()
    assert sorted((tuple(r) for r in got), key=str) == classes(rows)


def test_sets_beyond_the_broadcast_bound_and_empty_tables(spark, monkeypatch):
    rows = corpus(5)
    monkeypatch.setattr(ngrams, "FETCH", 0)
    got = ngrams.jaccard_components(spark.createDataFrame(rows, DOCS)).collect()
    assert sorted((tuple(r) for r in got), key=str) == classes(rows)
    assert ngrams.jaccard_components(spark.createDataFrame([], DOCS)).count() == 0


def test_one_key_of_a_third_of_all_rows(spark):
    copies = [(i, "the same short text again and again it is " + ("x" if i % 2 else "y"), "en", 0, "", "") for i in range(400)]
    rows = copies + [(1000 + i, " ".join(random.Random(i).choices(VOCAB, k=30)), "en", 0, "", "") for i in range(800)]
    got = {r["doc_id"]: r["component_id"] for r in ngrams.jaccard_components(spark.createDataFrame(rows, DOCS)).collect()}
    assert {got[i] for i in range(400)} == {0, 1} if got[0] != got[1] else {0}
    assert all(got[i] == i for i in range(1000, 1800))


def test_copies_that_are_alike_below_the_threshold_make_few_pairs(spark):
    """Twins that differ from all others by more than the threshold allows, not by words of their own: others were paired with them."""
    rng = random.Random(4)
    base, rows = [f"b{i}" for i in range(200)], []
    for d in range(60):
        w = list(base)
        for k in range(4, 170, 30):
            w[k + rng.randrange(20)] = f"own{d}x{k}"
        rows += [(2 * d, " ".join(w)), (2 * d + 1, " ".join([*w, f"end{d}"]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "cast(text as binary) as text")
    lists = ngrams.shared_lists(ngrams.listed(docs, 1, ngrams.element_set(" ".join(base).encode(), ngrams.WordNames()), 5, 80), 80)
    lists = ngrams.with_own(lists.where("pos >= 0")).selectExpr("*", "node as component")
    met = ngrams.met_pairs(lists, 80, 512)
    assert met.select("a", "b").distinct().count() == 60 and met.count() < 60 * 40  # each with its twin


def test_sizes_and_boundary():
    for a in range(1, 60):
        assert a - ngrams.needed(a, a) < ngrams.prefix(a)
        for b in ngrams.partners(a, 80, 1000):
            k = ngrams.needed(a, b)
            assert 100 * k >= 80 * (a + b - k) and 100 * (k - 1) < 80 * (a + b - k + 1)
    assert 1 <= ngrams.choose_boundary({3: 10, 9: 1000, 24: 5}) <= ngrams.LIGHT
