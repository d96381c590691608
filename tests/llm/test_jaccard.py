"""Near duplicates against all pairs compared by brute force."""

import random
import re

from entityspark.llm import jaccard
from entityspark.llm.common import components
from entityspark.llm.shingles import choose_bands


def sets_of(t):
    w = re.findall(r"\w+", (t or "").lower())
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(docs):
    sets = [sets_of(t) for _, t in docs]
    linked = [[j for j in range(len(docs)) if j != i and sets[i] and sets[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) - 1e-9] for i in range(len(docs))]
    group = list(range(len(docs)))
    while True:
        new = [min([group[i], *(group[j] for j in linked[i])]) for i in range(len(docs))]
        if new == group:
            break
        group = new
    first = {}
    for (d, _), g in zip(docs, group):
        first[g] = min(first.get(g, d), d)
    return sorted((d, first[g], len(x)) for (d, _), g, x in zip(docs, group, linked))


def corpus(seed, originals=40, hot=60):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    docs, k = [], 0
    for o in range(originals):
        text = [word() for _ in range(rng.choice([6, 30, 120]))]
        for _ in range(hot if o == 0 else rng.choice([1, 1, 2, 4])):
            t = text[:]
            for _ in range(rng.choice([0, 0, 1, 2, 4])):
                t[rng.randrange(len(t))] = word()
            docs.append((k, " ".join(t) + rng.choice(["", ".", " !"])))
            k += 1
    docs += [(k, None), (k + 1, ""), (k + 2, " ... "), (k + 3, "one two"), (k + 4, "One, two!"), (k + 5, "z " * 30_000), (k + 6, "z " * 20_000)]
    rng.shuffle(docs)
    return docs


def test_brute_force(spark):
    for block in (512, 16):
        docs = corpus(block)
        df = spark.createDataFrame([(d, t, 1, "x") for d, t in docs], "doc_id long, text string, class_id int, member string")
        got = sorted((r["doc_id"], r["class_id"], r["n_links"]) for r in jaccard.near_duplicates(df, block=block).collect())
        assert got == brute(docs)
    kept = jaccard.keep_one(df)
    assert kept.columns == df.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted({c for _, c, _ in got})


def test_repeats_and_empty(spark):
    schema = "doc_id long, text string"
    assert jaccard.near_duplicates(spark.createDataFrame([], schema)).count() == 0
    df = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f"), (None, "a b c d e f"), (3, None), (3, None), (4, "q")], schema)
    rows = sorted(((r["doc_id"] is None, r["doc_id"], r["class_id"], r["n_copies"], r["n_links"]) for r in jaccard.near_duplicates(df).collect()), key=str)
    assert rows == sorted([(False, 1, 1, 4, 3)] * 2 + [(False, 2, 1, 4, 3), (True, None, 1, 4, 3), (False, 4, 4, 1, 0)] + [(False, 3, 3, 1, 0)] * 2, key=str)
    assert sorted(r["doc_id"] for r in jaccard.keep_one(df).collect()) == [1, 3, 3, 4]


def test_bands():
    bands, rows = choose_bands(0.8, 0.9995)
    assert 1 - (1 - 0.8**rows) ** bands >= 0.9995 and bands * rows <= 128


def test_odd_rows(spark):
    words = "one two three four five six seven eight nine ten eleven twelve"
    rows = [(3, words, "a", 1, 1), (1, words + "!", "b", 2, 1), (2, "quite another text with words of its own", "c", 3, 1), (None, words, "d", 4, 1), (7, None, "e", 5, 1), (7, None, "f", 6, 1), (None, "", "g", 7, 1), (None, None, "h", 8, 1), (2, "quite another text with words of its own", "c", 3, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, `__tie` string, `__n_id` int, `first.id` int")
    kept = jaccard.keep_one(df)
    assert kept.columns == df.columns
    want = [rows[1], rows[2], *rows[4:8]]
    assert sorted(map(str, map(tuple, kept.collect()))) == sorted(map(str, want))
    assert jaccard.keep_one(df.limit(0)).count() == 0


def test_hot_classes(spark):
    """A third of all rows are one text, and as many have no words: every row comes out once, with whole counts."""
    rows = [(i, "the same long passage that a great many documents share word for word") for i in range(1500)] + [(i, "") for i in range(1500, 3000)] + [(i, f"text {i} stands alone with its number {i} and nothing else {i}") for i in range(3000, 4500)]
    got = {r["doc_id"]: r for r in jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(got) == 4500
    assert all(got[i]["class_id"] == 0 and got[i]["n_copies"] == 1500 and got[i]["n_links"] == 1499 for i in range(1500))
    assert all(got[i]["class_id"] == i and got[i]["n_links"] == 0 for i in range(1500, 4500))


def test_recall_at_the_threshold(spark):
    """The whole path, banding and the filter on signatures, on pairs whose similarity is only just enough."""
    rng = random.Random(12)
    docs, close = [], 0
    for k in range(0, 1600, 2):
        text = ["".join(rng.choice("abcdefghijklmnop") for _ in range(5)) for _ in range(100)]
        other = text[:]
        for at in (12, 88)[: 1 + k % 4 // 2]:
            other[at] = "new"
        docs += [(k, " ".join(text)), (k + 1, " ".join(other))]
    links = [len(sets_of(a[1]) & sets_of(b[1])) / len(sets_of(a[1]) | sets_of(b[1])) for a, b in zip(docs[::2], docs[1::2])]
    assert min(links) >= 0.8 and sum(x < 0.83 for x in links) == 400
    got = {r["doc_id"]: r["class_id"] for r in jaccard.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    close = sum(got[k + 1] == k for k in range(0, 1600, 2))
    assert close >= 0.999 * 800


def test_components_with_hubs(spark):
    rng = random.Random(2)
    edges = [(0, i) for i in range(1, 800)] + [(5000, i) for i in range(1000, 1400)] + [(2000 + i, 2001 + i) for i in range(60)] + [(rng.randrange(6000, 6400), rng.randrange(6000, 6400)) for _ in range(300)] + [(7, 7), (3, 900)]
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        if a != b:
            a, b = sorted((root(a), root(b)))
            up[b] = a
    want = sorted((x, root(x)) for x in list(up))
    df = spark.createDataFrame(edges, "a long, b long")
    for few in (10**9, 0):
        assert sorted(tuple(r) for r in components(df, "c", few=few).collect()) == want
