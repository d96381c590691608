"""The field's marginals against sums over all labellings; held-out accuracy on real rows."""

import itertools
import random
import re

import numpy as np
from pyspark.sql import functions as F

from entityspark.llm import toxicity as x


def test_marginals():
    rng = np.random.default_rng(1)
    lengths = np.array([4, 0, 1, 7, 2])
    r, moves = rng.gamma(1.0, 2.0, lengths.sum()), rng.gamma(1.0, 1.0, (2, 2))
    want, at, pairs = [], 0, np.zeros((2, 2))
    for n in lengths:
        total, one, mine = 0.0, np.zeros(n), np.zeros((2, 2))
        for y in itertools.product((0, 1), repeat=int(n)):
            p = np.prod([r[at + i] ** y[i] for i in range(n)]) * np.prod([moves[y[i], y[i + 1]] for i in range(n - 1)])
            total, one = total + p, one + p * np.array(y)
            np.add.at(mine, (list(y[:-1]), list(y[1:])), p)
        want.extend(one / total)
        pairs += mine / total
        at += n
    p, forward, backward = x.marginals(r, lengths, moves, full=True)
    assert np.allclose(p, want)
    begins = np.zeros(len(r), bool)
    begins[(np.cumsum(lengths) - lengths)[lengths > 0]] = True
    assert np.allclose(x.expected_moves(r, forward, backward, begins, moves), pairs)


def test_long_chains_in_parts():
    rng = np.random.default_rng(7)
    lengths = np.array([5000, 3, 0, 701, 700, 12_000, 1])
    r, moves = rng.gamma(0.3, 2.0, lengths.sum()) + 1e-9, np.array([[1.0, 0.05], [0.3, 0.8]])
    whole, parts = x.marginals(r, lengths, moves, full=True), x.marginals(r, lengths, moves, full=True, part=700)
    for a, b in zip(whole, parts):
        assert np.allclose(a, b, rtol=1e-6, atol=1e-12)
    assert len(x.marginals(np.zeros(0), np.array([0, 0]), moves)) == 0


def test_cases(spark):
    rng = random.Random(6)
    filler = lambda: " ".join("".join(rng.choice("abcdefg") for _ in range(3)) for _ in range(8))
    texts = [f"{filler()} {part} {filler()}" for part in ("you idiot and moron", "a fine day", "what an idiot moron", "the sun is out") * 40]
    field = x.fit(texts, [1, 0, 1, 0] * 40)
    copies = x.distinct_texts([np.array([1, 2, 3, 4, 5, 6]), np.array([1, 2, 3, 4, 5, 6]), np.array([], int), np.array([9])])
    assert copies.tolist() == [0, 2, 3]
    df = spark.createDataFrame([(1, "A fine idiot, moron!", 2.0), (2, None, 1.0), (3, "", 1.0), (4, "the sun " * 30_000, 1.0), (1, "A fine idiot, moron!", 2.0)], "doc_id long, text string, score double")
    rows = x.score_toxicity(df, field).collect()
    by = {r["doc_id"]: r for r in rows}
    assert len(rows) == 5 and by[1]["score"] > 0.5 > max(by[k]["score"] for k in (2, 3, 4))
    assert [(s["start"], s["end"]) for s in by[1]["spans"]] == [(7, 19)]
    assert x.score_toxicity(df.limit(0), field).count() == 0
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    assert all(r["score"] < 0.5 for r in x.score_toxicity(df, x.fit_toxicity(df, labels)).collect())


def plain_score(field, text):
    """The chance of each word by forward and backward sums over labels, word by word, and the document's score."""
    words = [w.lower() for w in re.findall(r"\w+", text or "")]
    own = [np.array([1.0, np.exp(np.clip(sum(field.weights[i] for i in x.features(w)), -30, 30))]) for w in words]
    forward, backward = [], []
    for k, o in enumerate(own):
        a = o if not k else o * (forward[-1] @ field.moves)
        forward.append(a / a.sum())
    for o in [None, *own[:0:-1]]:
        b = np.ones(2) if o is None else field.moves @ (o * backward[-1])
        backward.append(b / b.sum())
    p = [(f * b)[1] / (f * b).sum() for f, b in zip(forward, backward[::-1])]
    mass = sum(v for v in p if v >= field.floor)
    z = field.doc[0] + (field.doc[1:] @ np.array([np.log1p(mass), max(p), mass / len(p)]) if p else 0.0)
    return 1 / (1 + np.exp(-z)), p


def test_scores_by_loops(spark, sf):
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet").limit(150), spark.read.parquet(f"{sf}/labels.parquet")
    field = x.fit_toxicity(spark.read.parquet(f"{sf}/documents.parquet"), labels)
    got = {r["doc_id"]: r for r in x.score_toxicity(docs, field).collect()}
    for r in docs.collect():
        score, p = plain_score(field, r["text"])
        assert abs(got[r["doc_id"]]["score"] - score) < 1e-6
        inside = sum(len(re.findall(r"\w+", r["text"][s["start"] : s["end"]])) for s in got[r["doc_id"]]["spans"])
        assert inside == sum(v >= 0.5 for v in p)


def test_both_sides_of_few():
    """The sample is parted from `few` documents of a label in each part on, and not below; both tell labels apart."""
    rng = random.Random(4)
    texts = [" ".join("".join(rng.choice("abcdefg") for _ in range(3)) for _ in range(9)) + (" idiot moron" if i % 2 else "") for i in range(120)]
    fields = [x.fit(texts, [i % 2 for i in range(120)], few=n) for n in (1, 1000)]
    assert not np.allclose(fields[0].doc, fields[1].doc)
    for f in fields:
        score, _ = x.Tagger(f).score(["abc def idiot moron", "abc def"])
        assert score[0] > 0.5 > score[1]
    assert x.fit(texts, [i % 2 for i in range(120)], floor=0.9).floor == 0.9


def test_lower_case_that_adds_characters(spark):
    rng = random.Random(6)
    texts = [" ".join("".join(rng.choice("abcdefg") for _ in range(3)) for _ in range(9)) + (" idiot moron" if i % 2 else "") for i in range(160)]
    field = x.fit(texts, [i % 2 for i in range(160)])
    df = spark.createDataFrame([(1, "İİ \u0130bc an IDIOT moron abc")], "doc_id long, text string")
    r = x.score_toxicity(df, field).first()
    assert r["score"] > 0.5 and len(r["spans"]) == 1 and r["spans"][0]["start"] <= 10 and r["spans"][0]["end"] == 21


def test_repeated_ids_teach_once(spark):
    docs = spark.createDataFrame([(i, f"word{i} " + ("idiot moron" if i % 2 else "fine day")) for i in range(200)] + [(1, "zzz")] * 50 + [(None, "idiot")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)] + [(1, 0), (None, 1), (5, None)], "doc_id long, toxic int")
    once = docs.groupBy("doc_id").agg(F.min("text").alias("text"))
    a, b = x.fit_toxicity(docs, labels), x.fit_toxicity(once, labels)
    assert np.array_equal(a.weights, b.weights) and np.array_equal(a.doc, b.doc)


def test_held_out(spark):
    sf = "/root/testdata/sf0.1"
    rows = x.op7_toxicity(spark, sf).where("held_out").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").select("toxic", "predicted", "score").toPandas()
    right = rows.predicted == rows.toxic
    assert right.mean() > 0.98
    toxic = rows[rows.toxic == 1]
    assert toxic.predicted.mean() > 0.85 and rows[rows.toxic == 0].predicted.mean() < 0.01


def test_keep_clean(spark):
    """The pipeline's stage against the labels themselves."""
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    kept = x.keep_clean(docs, labels)
    assert kept.columns == docs.columns
    left = kept.select("doc_id").collect()
    ids = {r["doc_id"] for r in left}
    known = {r["doc_id"]: r["toxic"] for r in docs.select("doc_id").join(labels, "doc_id").collect()}
    toxic, clean = ([i for i, y in known.items() if y == k] for k in (1, 0))
    assert sum(i in ids for i in toxic) <= 0.15 * len(toxic) and sum(i in ids for i in clean) >= 0.99 * len(clean)
    assert len(left) >= 0.9 * docs.count() and len(ids) == len(left)


def test_keep_clean_of_odd_rows(spark):
    rng = random.Random(6)
    rows = [(i, " ".join("".join(rng.choice("abcdefg") for _ in range(3)) for _ in range(9)) + (" idiot moron" if i % 2 else ""), "a", 1) for i in range(160)]
    odd = [(None, "abc def", "a", 1), (None, None, "a", 1), (7, "", "b", 2), (None, "idiot moron idiot", "a", 1), (200, "abc", "c", 3), (200, "abc", "c", 3)]
    df = spark.createDataFrame(rows + odd, "doc_id long, text string, `__text` string, `a.b` int")
    labels = spark.createDataFrame([(i, i % 2) for i in range(160)], "doc_id long, toxic int")
    kept = x.keep_clean(df, labels)
    assert kept.columns == df.columns
    assert sorted(map(str, map(tuple, kept.collect()))) == sorted(str(r) for r in rows + odd if "idiot" not in (r[1] or ""))
    assert x.keep_clean(df.limit(0), labels).count() == 0
